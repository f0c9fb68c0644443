"""Page extraction, the pipeline's stages, and how the queries are registered."""

import html
import itertools
import math
import re
from collections import Counter

import corpus_pipeline
import pytest
from awkward_rows import AWKWARD, CLASHING, prose
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom.llm import decontaminate, html_text, labelled_pages, line_dedup, near_dedup, quality
from gridloom.llm import queries as llm_queries


@pytest.fixture(scope="module")
def model():
    return html_text.train()


def test_marginals_equal_the_sum_over_all_states(model):
    """Sum-product against every assignment of a small tree."""
    page = '<body><nav><a>x</a></nav><div class="content"><h1>Head</h1><p>Some text, here.</p></div><div class="ad"><p>Buy.</p></div></body>'
    nodes, _ = html_text.parse(page)
    n = len(nodes)
    weight, share, pairs = 0.0, [0.0] * n, [0.0] * 4
    for states in itertools.product((0, 1), repeat=n):
        score = model.start * states[0] + sum(math.log(model.evidence(nodes[i])) * states[i] for i in range(n))
        score += sum(model.step[2 * states[nodes[i].parent] + states[i]] for i in range(1, n))
        value = math.exp(score)
        weight += value
        for i in range(n):
            share[i] += value * states[i]
        for i in range(1, n):
            pairs[2 * states[nodes[i].parent] + states[i]] += value
    expected = [0.0] * 4
    assert model.marginals(nodes, expected) == pytest.approx([s / weight for s in share])
    assert expected == pytest.approx([p / weight for p in pairs])


def test_held_out_layouts(model):
    """Other draws of the labelled layouts than those trained on."""
    right = total = 0
    for page in labelled_pages.build(60, seed=99):
        nodes, blocks = html_text.parse(page)
        chance = model.marginals(nodes)
        right += sum((chance[i] >= 0.5) == bool(nodes[i].label) for i, _ in blocks)
        total += len(blocks)
    assert right / total > 0.9


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><h1>A &amp; B</h1><p>x  y\n z<br>w</p><p>one<p>two</article><footer>f</footer>", "A & B\nx y z w\none\ntwo"),
        ('<nav>m</nav><div class="ad">Buy &lt;it&gt;</div><article><p>T&eacute;xt &#8364; <b>bold</b>s</p></article>', "Téxt € bolds"),
        ("<article><p>a</p><script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>b</p></article>", "a\nb"),
        ('<article><p>The story, told in full here.</p><div class="comments"><p>Nice, I like it very much.</p></div></article>', "The story, told in full here."),
        ("<article><p>cut off in the midd", "cut off in the midd"),
        ("<article><p>1 < 2 &amp", "1 < 2 &"),
        (None, ""), ("", ""), ("   ", ""), ("<article></article>", ""),
        ('<header><h1>Site</h1></header><main><p>Short.</p></main><aside class="sidebar"><p>Long words, in a row, about else.</p></aside>', "Short."),
        ('<form><label>Name</label></form><article><ul><li>one<li>two</ul></article><div class="cookie-notice">We use cookies.</div>', "one\ntwo"),
    ],
)
def test_pages(model, page, text):
    assert model.text(page) == text


STORY = "<article><h1>Head</h1><p>The story, told in full here.</p></article>"


@pytest.mark.parametrize("tag", sorted(html_text.HIDDEN))
def test_pages_with_a_hidden_element_left_open(model, tag):
    want = "Head\nThe story, told in full here."
    assert model.text(f"<header><{tag} id=x>no</header>{STORY}") == want
    assert model.text(f"<body><{tag}>no{STORY}</body>") == want
    assert model.text(f"<article><p>One, two.<{tag}>no</p><p>Three, four.</p></article>") == "One, two.\nThree, four."
    # closed and nested ones take all that is in them
    inner = "" if tag in ("svg", "math", "select", "option", "button") else f"<{tag}>a</{tag}>"
    block = "" if tag in ("svg", "math") else "<p>no, not this.</p>"
    assert model.text(f"<article><p>One <{tag}>no {inner} no</{tag}> two.</p><{tag}>{block}no</{tag}<p>Three.</p></article>".replace(f"</{tag}<", f"</{tag}><")) == "One two.\nThree."


def test_pages_with_options_and_drawings(model):
    want = "Head\nThe story, told in full here."
    assert model.text(f"<form><input list=d><datalist id=d><option value=a><option value=b></datalist></form>{STORY}") == want
    assert model.text(f"<form><select><optgroup label=x><option>a<option>b<optgroup label=y><option>c</select></form>{STORY}") == want
    assert model.text(f"<datalist><option value=a><option value=b></datalist>{STORY}") == want
    assert model.text("<article><p>One <svg><svg><text>a</text></svg><text>b</text></svg> two.</p></article>") == "One two."
    assert model.text(f"{STORY}<script>var a = '<p>no</p>'") == want


def test_given_pages_equal_their_article(spark, sf, nothing):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in llm_queries.QUERIES["op9_tree_model_extraction"](spark, sf).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inside = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>?", "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1|h2)>", inside)]
        want = "\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)
    odd = spark.createDataFrame([(1, None, None, "x"), (1, "u", "<p>", "y"), (None, "u", "<article><p>" + "word " * 100_000, "z")], "page_id bigint, url string, html string, text string")
    found = html_text.extract(odd, html_text.train(odd)).collect()
    assert sorted(r.n_chars for r in found) == [0, 0, 499_999]
    assert html_text.extract(odd.limit(0), html_text.train(odd.limit(0))).count() == 0


LONG = "The council met again on Monday, and after some hours of talk it agreed on a plan for the old bridge, which had been shut since spring. "
LAYOUTS = {  # names that say nothing, none of them in the labelled pages; {} takes the story
    "three boxes": '<div class="zq"><a href=x>Home</a> <a href=y>News</a></div><div class="kvo">{}</div><div class="wub">Imprint 2020</div>',
    "two columns": '<div class="rr"><div class="ka"><ul><li><a href=x>One</a></li><li><a href=x>Two</a></li></ul></div><div class="kb">{}</div></div>',
    "nested": '<div id="qu"><div id="qv"><div id="qw">{}</div></div></div><div id="zz"><ul><li><a href=q>Last story</a></li><li><a href=q>Next one</a></li></ul></div>',
    "teasers below": '<div class="xa">{}</div><div class="xb"><h3>Mehr</h3><ul><li><a href=a>Another bridge shut</a></li><li><a href=a>The river rises</a></li></ul></div>',
    "sections": "<section><ul><li><a>Start</a></li></ul></section><section>{}</section><section><p>Some words of a title</p></section>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts_without_known_names(model, name):
    for parts in ([LONG * 2, LONG * 2], [LONG * 3, LONG, LONG * 2], [LONG * 2] * 6):
        for head in ("", "The bridge"):
            story = f"<h1>{head}</h1>" * bool(head) + "".join(f"<p>{p}</p>" for p in parts)
            want = "\n".join([head] * bool(head) + [p.strip() for p in parts])
            assert model.text(f"<body>{LAYOUTS[name].replace('{}', story)}</body>") == want


def test_reader_comments_stay_out_though_they_are_long(model):
    story = f"<h1>Title</h1><p>{LONG * 4}</p><p>{LONG * 3}</p>"
    page = f'<body><div class="xa">{story}</div><div class="comments"><p>I do not agree with this.</p><p>{LONG}</p></div></body>'
    assert model.text(page) == "\n".join(["Title", (LONG * 4).strip(), (LONG * 3).strip()])


def test_shapes_add_up_what_lies_below():
    nodes, _ = html_text.parse("<body><div><p>" + "a" * 100 + "</p><p><a>" + "b" * 100 + "</a></p></div><p></p></body>")
    assert [(n.tag, n.shape) for n in nodes[1:]] == [("body", "shape 3 2 0 0"), ("div", "shape 3 2 0 0"), ("p", ""), ("p", ""), ("p", "")]


def corpus(spark):
    rows = [(i, prose(i, 70)) for i in range(60)]
    rows += [(100 + i, prose(i, 70)) for i in range(0, 10)]  # exact copies
    rows += [(200 + i, prose(i, 70).replace(" ", "  ", 1).replace("a", "b", 1)) for i in range(10, 20)]
    rows += [(300 + i, prose(300 + i, 60) + "\n" + "a shared passage of words that many of the documents hold " * 6) for i in range(8)]
    rows += [(400 + i, " ".join(w.upper() + "!!" for w in prose(400 + i, 60).split())) for i in range(30)]
    rows += [(500, prose(500, 40) + " " + prose(900, 30) + " " + prose(501, 40)), (600, None), (601, ""), (None, prose(601, 50))]
    rows += [(3, prose(3, 70))]
    extra = ["x"] * len(CLASHING.split(", "))
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *extra) for i, t in rows], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}")


def test_stages(spark, tmp_path):
    docs = corpus(spark)
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(400 + i, 0) for i in range(30)], "doc_id bigint, quality int")
    benchmark = spark.createDataFrame([(1, prose(900, 30)), (2, None)], "item_id bigint, text string")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = seen[name][1]
    ids = {n: Counter(r.doc_id for r in b.select("doc_id").collect()) for n, (_, b) in seen.items()}

    # 1: as the operator scores
    before, after = seen["quality classifier"]
    scored = quality.classify(before, labels).collect()
    assert ids["quality classifier"] == Counter(r.doc_id for r in scored if r.predicted)
    assert not any(400 <= (i or 0) < 430 for i in ids["quality classifier"]) and set(range(60)) <= set(ids["quality classifier"])
    # 2: copies go, clean documents stay whole, the shared passage stays once
    before, after = seen["line dedup"]
    texts = {r.doc_id: r.text for r in after.where("doc_id is not null").collect()}
    assert not any(100 <= i < 110 for i in texts) and all(texts[i] == prose(i, 70) for i in range(60))
    assert sum("a shared passage" in (t or "") for t in texts.values()) == 1 and {300 + i for i in range(8)} <= set(texts)
    removed = {r.doc_id: r for r in line_dedup.dedup(before.select("doc_id", "text")).collect()}
    assert all(r.text == texts[i] for i, r in removed.items() if i in texts)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after.collect())
    # 3: one of each group
    before, after = seen["near-dedup"]
    linked = near_dedup.link(before, 5, 80).collect()
    assert ids["near-dedup"] == Counter(r.doc_id for r in linked if r.kept)
    # 4: the document with the item goes, no other
    before, after = seen["decontamination"]
    found = {r.doc_id for r in decontaminate.search(before, benchmark, 0.05).collect()}
    assert found == {500} and ids["decontamination"] == Counter({i: n for i, n in ids["near-dedup"].items() if i != 500})
    # 5: all tokens of all that is left
    before, after = seen["best-fit packing"]
    assert set(ids["best-fit packing"]) == set(ids["decontamination"])
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_line_stage_keeps_the_first_of_each_line(spark):
    """No line with words leaves the corpus: what goes is in an earlier place."""
    passage = [prose(700 + k, 20).replace("\n", " ") for k in range(12)]
    rows = [(0, "\n".join(passage)), (1, "\n".join(passage) + "\none line of its own"), (2, "\n".join(passage)), (3, "\n".join(passage) + "\nTitle")]
    rows += [(9, "\n".join(["the same line again here"] * 50)), (10, " \n" + passage[0] + "\n"), (11, "two words"), (12, ""), (13, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert {i for i, _ in rows} - set(got) == {2, 10}
    assert got[1] == "one line of its own" and got[9] == "the same line again here" and got[3] == "Title" and got[13] is None
    lines = {x.strip() for t in got.values() for x in (t or "").split("\n")}
    assert {x.strip() for _, t in rows for x in (t or "").split("\n")} <= lines


def test_stages_take_empty_tables(spark, tmp_path):
    docs = corpus(spark).limit(0)
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        docs = out if "text" in out.columns else docs


def test_all_operators_and_the_pipeline_are_registered():
    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
    assert len(AWKWARD) > 10


def test_line_stage_keeps_columns_named_like_its_own(spark):
    import corpus_pipeline

    rows = [(1, "one two three four five\nsix seven eight nine ten", 5, "a", "b", "c"), (2, "one two three four five\neleven twelve and more words", None, "d", None, "f"), (3, None, 0, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int, n_lines string, _gone_x string, others string")
    found = corpus_pipeline.drop_lines(spark, docs, "")
    assert found.columns == docs.columns and found.schema["n_lines"].dataType == docs.schema["n_lines"].dataType
    got = {r.doc_id: tuple(r) for r in found.collect()}
    assert got[1] == (1, rows[0][1], len(rows[0][1]), "a", "b", "c")
    assert got[2] == (2, "eleven twelve and more words", 28, "d", None, "f") and got[3][3:] == (None, None, None)
